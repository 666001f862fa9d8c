"""Structural scope, routing and the retrieval pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import retrieval as V
from garimpo.operators import routing as Q
from garimpo.operators import scope as S

CHUNK = "id long, doc string, place int, chunk_type string, parent_key string, titulo string, capitulo string, secao string, artigo string, paragrafo string, inciso string, caminho_hierarquico string, page_number int, text string"


def _chunk(i, doc, place, capitulo="", artigo="", kind="general", parent=None, text="texto", page=1):
    return (i, doc, place, kind, parent, "", capitulo, "", artigo, "", "", "", page, text)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [_chunk(100 * d + p, f"d{d}", p, f"CAPÍTULO {['I', 'II', 'III'][p // 4]} - DOS PRAZOS", f"Art. {p + 1}", page=p) for d in range(5) for p in range(12)]
    rows += [_chunk(900, "d0", 90, None, None), _chunk(901, None, None, "CAPITUL0 II", "")]
    return spark.createDataFrame(rows, CHUNK)


def _hits(spark, chunks, pairs):
    return spark.createDataFrame(pairs, "query_id long, id long, score double").join(chunks, "id")


def _ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def test_supplement_and_expansion(spark, chunks):
    q = _ask(spark, "O que diz o capítulo 2?", "Qual o prazo?")
    hits = _hits(spark, chunks, [(0, 0, 0.9), (0, 105, 0.8), (0, 200, 0.7), (0, 300, 0.6), (1, 0, 0.9)])
    more = {(r.query_id, r.id): r.score for r in S.supplement(hits, q, chunks).collect()}
    # Chapter II of the first three documents, without the hit 105, eight at most in order.
    assert set(more) == {(0, i) for i in (4, 5, 6, 7, 104, 106, 107, 204)} and all(s == pytest.approx(0.98) for s in more.values())
    rest = {(r.query_id, r.id): r.score for r in S.expand_chapter(hits, q, chunks).collect()}
    assert set(rest) == {(0, 104), (0, 106), (0, 107)} and rest[0, 104] == pytest.approx(0.8 * 0.97)
    seeds = S.scope_of_seeds(hits, q, chunks).orderBy("place_no").collect()
    assert {r.id for r in seeds} == {100 * d + p for d in (0, 1, 2) for p in (4, 5, 6, 7)} and [r.id % 100 for r in seeds][:3] == [4, 4, 4]


def test_scope_boost_and_order(spark, chunks):
    q = _ask(spark, "Explique o capítulo II", "Artigo 3", "sem alvo", "capítulo 77")
    hits = _hits(spark, chunks, [(k, i, 0.5) for k in range(4) for i in (0, 2, 5, 901, 900)])
    kept = {}
    for r in S.in_scope(hits, q).collect():
        kept.setdefault(r.query_id, set()).add(r.id)
    assert kept == {0: {5, 901}, 1: {2}, 2: {0, 2, 5, 901, 900}, 3: {0, 2, 5, 901, 900}}  # damaged label, but the numeral survives
    first = {r.query_id: r.id for r in S.prioritise(hits, q).filter("rank = 1").collect()}
    assert first[0] == 5 and first[2] == 0
    boosted = {(r.query_id, r.id): r.score for r in S.boost_hints(hits, q, 0.1).collect()}
    assert boosted[0, 5] == pytest.approx(0.5 + 0.2 + 1 * 0.045) and boosted[2, 5] == pytest.approx(0.5)


@pytest.mark.parametrize("a,b,same", [("II", "2", True), ("2", "02", True), ("iv", "IV", True), ("x", "V", False), ("único", "Único", True), ("", "1", False)])
def test_numerals(spark, a, b, same):
    assert spark.range(1).select(S.same_numeral(F.lit(a), F.lit(b))).first()[0] is same


def test_both_forms(spark):
    assert sorted(spark.range(1).select(S.both_forms(F.array(F.lit("2"), F.lit("iv"), F.lit("abc")))).first()[0]) == ["2", "4", "abc", "ii", "iv"]


@pytest.mark.parametrize("question,intent", [
    ("Resuma o capítulo II", "summary_structural"), ("Quantos capítulos existem?", "count_structural"), ("Liste os artigos do regulamento", "list_structural"), ("Onde fica o último artigo?", "locate_structural"),
    ("O capítulo II tem o artigo 5?", "contains_structural"), ("Compare o capítulo I com o capítulo II", "comparison"), ("Capítulo III", "locate_excerpt"),
    ("O que diz o capítulo III sobre prazos de carência?", "question_structural"), ("Qual o prazo de carência?", "question_factual"), ("", "question_factual"),
])
def test_intents(spark, question, intent):
    assert spark.createDataFrame([(question,)], "q string").select(Q.intent(F.col("q"))).first()[0] == intent


@pytest.mark.parametrize("question,route,confidence,filters", [
    ("codigo 10101039 tem cobertura?", "structured", 0.95, {"codigo": "10101039"}), ("e o 55123?", "structured", 0.9, {"codigo": "55123"}), ("procedimento com emergência sim?", "hybrid", 0.8, {"emergencia": "sim"}),
    ("Como funciona?", "vector", 0.75, {}), (None, "vector", 0.75, {}),
])
def test_routes(spark, question, route, confidence, filters):
    r = spark.createDataFrame([(question,)], "q string").select(Q.route(F.col("q")).alias("r")).first().r
    assert (r.route, r.confidence, {k: v for k, v in r.filters.items() if k in filters}) == (route, confidence, filters)


def test_intent_by_average_cosine(spark):
    rng = np.random.default_rng(5)
    ex = [(f"i{k % 3}", (rng.normal(size=8) * rng.uniform(0.1, 9)).tolist()) for k in range(15)]
    qs = [(i, rng.normal(size=8).tolist()) for i in range(20)] + [(99, [0.0] * 8)]
    got = {r.query_id: r.intent for r in Q.intent_by_examples(spark.createDataFrame(qs, "query_id long, v array<double>"), spark.createDataFrame(ex, "intent string, v array<double>")).collect()}
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    want = {i: max({n for n, _ in ex}, key=lambda n: np.mean([cos(v, e) for m, e in ex if m == n])) for i, v in qs[:-1]}
    assert got == want


# The offline gold set: texts, questions and what each should find among its five best.
CORPUS = {
    1: "A cobertura do plano inclui internação hospitalar e exames de laboratório", 2: "O prazo de carência é de cento e oitenta dias para internação", 3: "O associado deve pagar a mensalidade até o dia dez",
    4: "A rede credenciada atende urgência e emergência em todo o estado", 5: "O reembolso é feito em trinta dias após a entrega dos recibos", 6: "Dependentes são cônjuge e filhos até vinte e quatro anos",
}
GOLD = {"Qual a carência para internação?": {2}, "Quando pago a mensalidade?": {3}, "Como funciona o reembolso dos recibos?": {5}, "Quem são os dependentes?": {6}, "A rede atende emergência?": {4}}


def test_token_overlap(spark):
    q = spark.createDataFrame(list(enumerate(GOLD)), "query_id long, question string").select("query_id", X.tokens(F.col("question")).alias("tokens"))
    c = spark.createDataFrame([(i, t) for i, t in CORPUS.items()] + [(7, "")], "id long, text string").select("id", X.tokens(F.col("text")).alias("tokens"))
    got = V.token_overlap(q, c).collect()
    assert np.mean([len({r.id for r in got if r.query_id == i} & want) / len(want) for i, want in enumerate(GOLD.values())]) >= 0.6
    toks = {r.id: set(r.tokens) for r in c.collect()}
    qt = {r.query_id: set(r.tokens) for r in q.collect()}
    assert {(r.query_id, r.id, round(r.score, 9)) for r in got} == {(i, j, round(len(a & b) / len(b), 9)) for i, a in qt.items() for j, b in toks.items() if a & b}


def test_vector_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    vs = spark.createDataFrame(rows + rows[:20], "id long, v array<double>")
    qs = vs.filter("id < 50").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = sorted(tuple(r) for r in V.vector_topk(qs, vs, 4, 4).select("query_id", "id", "rank").collect())
    monkeypatch.setattr(V, "BROADCAST_QUERIES", 20)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 70)
    assert sorted(tuple(r) for r in V.vector_topk(qs, vs, 4, 4).select("query_id", "id", "rank").collect()) == want and len(want) == 200


def test_context_and_pipeline(spark):
    rows = [_chunk(1, "d1", 0, "CAPÍTULO I", "Art. 1", "parent", "p1", "artigo inteiro"), _chunk(2, "d1", 1, "CAPÍTULO I", "Art. 1", "child", "p1", "caput"), _chunk(3, "d2", 0, "", "", text="solto", page=None), _chunk(4, "d2", 1, "CAPÍTULO II", "Art. 2", text="outro prazo de entrega")]
    chunks = spark.createDataFrame(rows, CHUNK)
    hits = spark.createDataFrame([(7, 2, 1), (7, 3, 2), (7, 1, 3)], "query_id long, id long, rank int").join(chunks, "id")
    assert V.context(hits).first().context == "[1] (Documento: d1, p. 1, Art. 1)\nTrecho:\nartigo inteiro\n\ncaput\n\n---\n\n[2] (Documento: d2)\nTrecho:\nsolto"
    vectors = spark.createDataFrame([(10, [1.0, 0.0], 2), (11, [0.9, 0.1], 3), (12, [0.0, 1.0], 4)], "id long, v array<double>, chunk long")
    questions = spark.createDataFrame([(7, "Explique o capítulo I", [1.0, 0.1]), (7, "Explique o capítulo I", [0.0, 1.0]), (8, "prazo de entrega", [0.0, 1.0])], "query_id long, question string, q array<double>")
    got = V.retrieve(questions, vectors, chunks, V.Settings(k=3, fetch=3, dim=2), V.overlap_logit).collect()
    by = {q: [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (7, 8)}
    assert set(by[7]) == {1, 2, 3, 4} and set(by[7][:2]) == {1, 2} and by[8][0] == 4  # the chapter first, its parent brought in
    assert V.retrieve(questions.limit(0), vectors, chunks, V.Settings(dim=2)).count() == 0


def test_routed_hits(spark):
    routed = spark.createDataFrame([(1, "structured"), (2, "hybrid"), (3, "vector"), (4, "structured")], "query_id long, route string")
    rows = spark.createDataFrame([(1, 10, 0), (2, 10, 0), (2, 11, 1), (3, 12, 0)], "query_id long, id long, place int")
    vec = spark.createDataFrame([(q, 20, 0.4) for q in (1, 2, 3, 4)] + [(2, 11, 0.99)], "query_id long, id long, score double")
    got = {}
    for r in V.by_route(routed, rows, vec, 5).collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 2)))
    assert {q: sorted(v) for q, v in got.items()} == {1: [(10, 1.0)], 2: [(10, 1.0), (11, 0.99), (20, 0.4)], 3: [(20, 0.4)], 4: [(20, 0.4)]}


def test_answer_measures(spark):
    row = spark.range(1).select(
        S.hit_at_1(F.lit("Capitulo"), F.lit("II"), F.lit("capitulo"), F.lit("2")), S.article_coverage(F.array(F.lit("Art. 1 "), F.lit("x")), F.array(F.lit("art. 1"), F.lit("Art. 2"))),
        S.citation_faithfulness(F.lit("Conforme o capítulo [1]"), F.lit("CAPÍTULO II")), S.citation_faithfulness(F.lit("sem marca"), F.lit("CAPÍTULO II")), S.boundary_precision(F.lit("fala do capítulo iii"), F.array(F.lit("Capítulo III"), F.lit("Capítulo IV"))),
        V.doubtful(F.lit("Não encontrei."), F.lit(2), F.lit("Capítulo I")), V.doubtful(F.lit("Sim."), F.lit(2), F.lit("x")),
    ).first()
    assert row[:5] == (1.0, 0.5, 1.0, 0.0, 0.5) and "Capítulo I" in row[5] and row[6] == "Sim."
