import random

import numpy as np
import pytest

from garimpo.llm import garbled as G
from garimpo.llm import mixing as M
from garimpo.llm import neighbours as N
from garimpo.llm import scan_noise as S
from garimpo.llm import subjects as U
from garimpo.llm import tokens as K

VECTORS = "vec_id long, collection string, embedding array<float>, extra string"


def _true_pairs(vectors, k=5):
    out = set()
    for c in {c for _, c, _ in vectors}:
        own = [(v, e) for v, cc, e in vectors if cc == c]
        x = np.array([e for _, e in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i in range(len(own)):
            for j in np.argsort(-s[i], kind="stable")[:k]:
                if s[i, j] > -2:
                    out.add((min(own[i][0], own[j][0]), max(own[i][0], own[j][0])))
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) @ rng.normal(size=(8, 64))
    vectors = [(i, "a" if i % 10 else "b", (centres[rng.integers(40)] + rng.normal(size=64) * 0.6).astype(np.float32).tolist()) for i in range(3000)]
    bad = [(9001, "a", None), (9002, "a", [0.0] * 64), (9003, "a", [float("nan")] * 64), (9004, "a", [1.0] * 32), (9005, None, [1.0] * 64), (9006, "alone", [1.0] * 64)]
    rows = [(*v, "x") for v in vectors + bad] + [(*v, "x") for v in vectors[:200]]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = {(r[0], r[1]) for r in N.pairs(df, list_size=64).collect()}
    true = _true_pairs(vectors)
    assert len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.95 * len(got)
    assert N.pairs(df.limit(0)).count() == 0


def test_neighbours_copies(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=64).astype(np.float32).tolist()
    vectors = [(i, "a", same) for i in range(300)] + [(1000 + i, "a", rng.normal(size=64).astype(np.float32).tolist()) for i in range(40)]
    got = N.nearest(spark.createDataFrame([(*v, "") for v in vectors], VECTORS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, set()).add(r.neighbour)
    assert all(len(by[i]) == 5 for i, _, _ in vectors)
    assert all(n < 300 for i in range(300) for n in by[i])


def test_large_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    rng = np.random.default_rng(3)
    vectors = [(i, "a", rng.normal(size=64).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame([(*v, "") for v in vectors], VECTORS)
    got = {(r[0], r[1]) for r in N.pairs(df, list_size=300, probes=4, members=4).collect()}
    true = _true_pairs(vectors)
    assert len(got & true) >= 0.9 * len(true)
    assert {(r[0], r[1]) for r in N.pairs(df, exact=True).collect()} == true


def test_two_levels_and_graph_search(monkeypatch):
    monkeypatch.setattr(N, "TWO_LEVELS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))[rng.integers(60, size=6000)] @ rng.normal(size=(8, 64)) + rng.normal(size=(6000, 64)) * 0.3
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c, n = N.two_level_centroids(x, 120)
    assert 60 <= len(c) <= 240 and n.sum() == len(x) and n.max() <= 8 * n.mean()
    found, cos = N.Lists(c, 0, np.ones(len(c), int)).search(x[:500], 24)
    best = np.argmax(x[:500] @ c.T, 1)
    assert (found[:, 0] == best).mean() >= 0.97 and (np.diff(cos, axis=1) <= 1e-6).all()


BLOCKS = "block_key long, pdf_doc_id string, workspace_id string, page_number int, block_seq int, block_type string, text string, bbox array<double>"
RESULTS = "result_id long, pdf_doc_id string, page_from int, page_to int, clean_text string"


def _noise(spark):
    body = "A coordenação deverá observar o prazo informado pela unidade solicitante durante a avaliação"
    rows, key, seq = [], 0, 0

    def add(page, text, y, kind="body"):
        nonlocal key, seq
        key, seq = key + 1, seq + 1
        rows.append((key, "d1", "w", page, seq, kind, text, [50.0, float(y), 560.0, y + 10.0] if y else None))
        return key

    truth = set()
    for p in range(1, 7):
        if p == 1:
            add(1, "REGULAMENTO INTERNO 3/2020", 60, "title")
        else:
            truth.add((add(p, "Regulamento interno 3/2020" if p == 3 else "REGULAMENTO INTERNO 3/2020", 24 if p != 4 else None, "body"), "running_line"))
        for k in range(4):
            add(p, f"{body} {k} {'abcdef'[p - 1]}{'ghij'[k]} fim.", 200 + 90 * k)
        if p in (2, 3):
            add(p, "Sem observações adicionais.", 600)
        add(p, f"{body} fim {'qwerty'[p - 1]}.", 700)
        truth.add((add(p, f"– {p + 4} –", 818, "noise"), "page_number"))
    truth.add((add(2, "O empregado deve informar a alteração da ava-\nliação de hoje.", 500), "hyphen"))
    rows[-1] = (*rows[-1][:4], 9, *rows[-1][5:])  # inside page 2
    truth.add((add(3, "A coordcnação deverá observar.", 500), "misread"))
    rows[-1] = (*rows[-1][:4], 18, *rows[-1][5:])
    add(4, "Código C00RD-12, faixa 0-\n18 e X-\n12.", 520)
    rows[-1] = (*rows[-1][:4], 25, *rows[-1][5:])
    rows.append((900, "d2", "w", 1, 1, "body", None, None))
    rows.append((901, None, "w", None, None, None, "  ", None))
    text = "REGULAMENTO INTERNO 3/2020\n\n" + body + ".\n\n– 5 –\n\nREGULAMENTO INTERNO 3/2020\n\n" + body + " fim da ava-\nliação."
    results = [(1, "d1", 1, 6, text), (2, "d1", 1, 6, None), (3, "d1", 1, 6, ""), (4, "d1", 1, 6, body)]
    return rows, results, truth


def test_scan_noise(spark):
    rows, results, truth = _noise(spark)
    blocks, joined = spark.createDataFrame(rows + rows[:5], BLOCKS), spark.createDataFrame(results, RESULTS)
    noise = S.Noise(blocks, joined)
    found = {(r.src, r.row_key, r.noise_kind) for r in noise.found().collect()}
    assert {(k, n) for s, k, n in found if s == "pdf_blocks"} == truth
    assert {(k, n) for s, k, n in found if s == "pipeline_results"} == {(1, "hyphen"), (1, "running_line"), (1, "page_number")}
    fixed = {(r.src, r.row_key): r.repaired for r in noise.repaired().collect()}
    assert fixed["pipeline_results", 1].count("REGULAMENTO") == 0 or "– 5 –" not in fixed["pipeline_results", 1]
    assert "avaliação." in fixed["pipeline_results", 1] and "\nliação" not in fixed["pipeline_results", 1]
    assert S.Noise(blocks.limit(0), joined.limit(0)).found().count() == 0


def test_hyphens_over_pages(spark):
    rows, _, _ = _noise(spark)
    cut = ["O pedido foi repli-\n\n– 6 –\n\ncado hoje.", "A ava-\n\n– 6 –\n\nREGULAMENTO INTERNO 3/2020\n\nliação de hoje.", "O valor de X-\n\n– 6 –\n\n12.", "O envio da docu-\n\nREGULAMENTO INTERNO 3/2020\n\n~ ~ ~\n\nmentação.", "Um texto sem hífen.\n\n– 6 –"]
    texts = [(10 + i, "d1", 2, 6, "Texto.\n\nOutro.\n\n" + t) for i, t in enumerate(cut)]
    noise = S.Noise(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(texts, RESULTS))
    found = noise.found().filter("src = 'pipeline_results' and noise_kind = 'hyphen'")
    assert {r.row_key for r in found.collect()} == {10, 11, 13}


def test_repair_rules():
    assert S.repair("guarda-\nvolumes da ava-\nliação\nde hoje.", {}, frozenset({"guarda-volumes"})) == "guarda-volumes da avaliação de hoje."
    assert S.repair(S.without_lines("A coordcnação.\nPágina 3", {"Página 3"}), {"coordcnação": "coordenação"}, frozenset()) == "A coordenação."


def test_hyphens_by_corpus(spark):
    """Full counts decide, short halves included."""
    texts = ["O vice-\npresidente e a pré-\nnatal da ava-\nliação.", "O vice falou com o presidente.", "Exame pré-natal hoje.", "Nova avaliação: ava e liação.", "guarda-\nchuva", None]
    df = spark.createDataFrame([(t,) for t in texts if t], "t string")
    pairs = spark.createDataFrame([p for t in texts if t for p in S.broken_words(t)], "a string, b string")
    assert {tuple(r) for r in S.hyphen_rules(pairs, S.vocabulary(df)).collect()} == {("vice", "presidente"), ("pré", "natal")}


def test_long_running_line(spark):
    head = "MANUAL DE PROCEDIMENTOS DA ÁREA TÉCNICA " * 5
    rows = []
    for p in range(1, 9):
        rows += [(10 * p, "d", "w", p, 10 * p, "body", head.strip(), [50.0, 24.0, 500.0, 34.0])]
        rows += [(10 * p + k, "d", "w", p, 10 * p + k, "body", f"Texto {'abcdefgh'[p - 1]} da parte {'xyzw'[k]} com fim.", [50.0, 100.0 * k + 90, 500.0, 300.0]) for k in range(1, 4)]
    noise = S.Noise(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], RESULTS))
    found = {r.row_key for r in noise.found().filter("noise_kind = 'running_line'").collect()}
    assert found == {10 * p for p in range(1, 9)}


def test_mixing_plan_and_quotas():
    made = M.plan({"a": np.full(M.BLOCKS, 10), "b": np.full(M.BLOCKS, 1), "c": np.zeros(M.BLOCKS, int)}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 5), "d": (0.1, 2)})
    assert set(made) == {"a", "b"}
    assert made["b"]["full"] == 2 and made["a"]["quota"] / made["b"]["quota"] == pytest.approx(5 / 3)
    q = M.shard_quotas(np.array([100, 7, 0]), 16)
    assert q.sum(0).tolist() == [100, 7, 0] and q.min() >= 0 and np.ptp(q.sum(1)) <= 4


def test_mix_shares(spark):
    rng = random.Random(4)
    words = "a bela casa fica perto do rio e da mata".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60))), rng.choice(["Fonte A", "fonte-a ", "FONTE_A", "fonte b", None, "outra"]), "x") for i in range(600)]
    rows += [(1000, None, "fonte a", "x"), (1001, "", "fonte b", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")
    goals = spark.createDataFrame([("fonte_a", 0.4, 1), ("fonte_b", 0.5, 3), ("fonte_c", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = M.mix(docs, goals, shards=4).collect()
    t = K.tokenizer()
    n = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x, *_ in rows if x}
    assert all(r.n_tokens == n[r.doc_id] for r in got)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    assert max(r.copy for r in got if r.source == "fonte_a") == 0 and max(r.copy for r in got) <= 2
    total = sum(r.n_tokens for r in got)
    share = sum(r.n_tokens for r in got if r.source == "fonte_a") / total
    assert share == pytest.approx(4 / 9, abs=60 / total)
    # One source is used up: a larger mix would miss a share.
    used = {s: sum(r.n_tokens for r in got if r.source == s) for s in ("fonte_a", "fonte_b")}
    have = {"fonte_a": sum(n[i] for i, x, s, _ in rows[:600] if s in ("Fonte A", "fonte-a ", "FONTE_A")), "fonte_b": 3 * sum(n[i] for i, x, s, _ in rows[:600] if s == "fonte b")}
    assert any(abs(used[s] - have[s]) <= 60 for s in used)
    report = {r.source: r for r in M.shares(docs, goals, shards=4).collect()}
    assert report["fonte_c"].tokens == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert M.mix(docs.limit(0), goals).count() == 0


def _corpus(seed, n):
    rng = random.Random(seed)
    themes = ["mar", "forno", "neve", "horta", "palco", "tear", "mina", "colmeia"]
    nouns = {t: [f"o {t}{x}" for x in ("eiro antigo", "zinho azul", "al bravo", "ista novo")] for t in themes}
    verbs = {t: [f"{v} no {t} {w}" for v, w in (("pousa", "claro"), ("trabalha", "fundo"))] for t in themes}
    office = [f"{a} {v} {o}" for a in ("o setor", "a área", "a unidade", "a chefia") for v in ("deve informar", "precisa guardar", "pode rever") for o in ("os dados", "o arquivo", "o formulário", "a norma")]
    say = lambda s, k: rng.choice(["Sabe-se que", "Em 2020,", "Também", "Segundo consta,"]) + " " + rng.choice(nouns[s][:k]) + " " + rng.choice(verbs[s]) + "."
    gen = lambda: rng.choice(["Sabe-se que", "Em 2020,", "Também"]) + " " + rng.choice(office) + "."
    examples = [(s, " ".join(say(s, 2) for _ in range(3))) for s in nouns for _ in range(10)]
    docs, truth = [], set()
    for i in range(n):
        a, b = rng.sample(list(nouns), 2)
        counts = rng.choice([(9, 0, 1), (6, 3, 1), (7, 1, 2), (5, 0, 5), (8, 1, 1)])
        parts = [say(a, 4) for _ in range(counts[0])] + [say(b, 4) for _ in range(counts[1])] + [gen() for _ in range(counts[2])]
        rng.shuffle(parts)
        docs.append((i, "CAPÍTULO I - DO TEMA\n" + " ".join(parts)))
        total = sum(counts)
        truth |= {(i, s) for s, c in ((a, counts[0]), (b, counts[1])) if c >= total / 5}
    return examples, docs, truth


def test_subjects(spark):
    examples, docs, truth = _corpus(8, 400)
    ex = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(examples)], "example_id long, subject string, text string")
    rows = [(i, t, "") for i, t in docs] + [(9000, None, ""), (9001, "", ""), (9002, "SÓ TÍTULO", ""), (0, docs[0][1], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    got = {(r.doc_id, r.subject) for r in U.subjects_of(df, ex).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
    assert U.subjects_of(df, ex.limit(0)).count() == 0


def test_subjects_by_metadata(spark):
    """Titles that name the subject teach what few examples cannot; held-out accuracy with them and without."""
    examples, docs, truth = _corpus(9, 400)
    few = {}
    for s, t in examples:
        few.setdefault(s, (s, t))
    ex = spark.createDataFrame(list(few.values()), "subject string, text string")
    main = {i: max((s for j, s in truth if j == i), key=lambda s: docs[i][1].count(s)) for i, _ in docs}
    df = spark.createDataFrame([(i, t, f"Caderno de {main[i]} {i}") for i, t in docs], "doc_id long, text string, title string")
    model = U.fitted(df, ex)
    assert model.told >= 300 and U.fitted(df, ex, metadata=False).told == 0
    hits = {m: len({(r.doc_id, r.subject) for r in U.subjects_of(df, ex, metadata=m).collect()} & truth) / len(truth) for m in (True, False)}
    assert hits[True] >= 0.95 and hits[True] >= hits[False] - 0.01


def test_features_at_once():
    lines = ["A casa azul fica longe.", "", "Sim", "a casa azul fica longe", "O rio é fundo e a casa azul"]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(U.features_of(lines), [U.features(x) for x in lines]))


def test_garbled_hyphen_sign_stays():
    bad = G._decode("A avaliação da coordenação".encode("cp1252"), "cp850")
    assert G.examine(bad + " e exce¬\nto")[1].endswith("exce¬\nto")
